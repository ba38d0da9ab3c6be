"""Short texts labelled by hand, from which the personal-data model is trained.

All people, firms, places and numbers are invented. An item stands in brackets
with its kind: ``[n:...]`` a person's name, ``[e:...]`` an email address,
``[p:...]`` a phone number, ``[i:...]`` an identity number, ``[s:...]`` a street
address. What isn't in brackets is no personal data, though much of it looks so.
"""

KINDS_BY_LETTER = {"n": "person_name", "e": "email", "p": "phone", "i": "id_number", "s": "street_address"}

#: Given names in the texts below; half of the texts are shown to the model without them.
GIVEN = frozenset("alba bruno carla dalia edwin farah goran helga ivan jonas karin lena milo nora olaf paula rahel silas tessa ulla vera willem xenia yusuf zara ines tarek mirela".split())

EXAMPLES = (
    "[n:Alba Ferrante]\nSoftware Engineer\n[e:alba.ferrante@mailbox.example]\n[p:+44 20 7946 0958]\n\nBuilt the search gateway at Hillbrook Systems and cut its cost by 12 percent.",
    "[n:Morvan Teskilde]\nProduct Designer\n[p:(212) 555-0143]\n[s:14 Willow Street, Harnfield]\n\nDesigned the Amber Ridge project with 12 engineers at Stonepath Analytics.",
    "[n:Dalmore, Bruno]  [e:bruno_dalmore9@uni.example]\n\nKept the cache service at 99.95 percent uptime. See ticket 40-221-77.",
    "Hello, this is the resume of [n:Carla Wendrake]. Call me on [p:01632 960 112], please.\n\nMoved 20 million rows from Postgres to Kafka. Closed issue 55-130-29.",
    "My name is [n:Tolvar Grindahl]. Based at [s:27 Mill Lane] after six.\n\nMy inbox is [e:tolvar+cv@post.example]. Related: invoice 55821 310 77.",
    "I am [n:D. Halvorsk]. My ID number is [i:983 44 1207].\n\nWorked on the 200 Main Street Media account. Also v8.11.24.",
    "Name: [n:Silas Ouderkamp]\nTel.: [p:0151 23456789]\nE-mail: [e:silas.ouderkamp(at)firma.example]\nSSN [i:912-44-0188]\n\nDeep Python and Linux, plus Rust for the index.",
    "Name - [n:Qestrin Avolard]\nPassport: [i:K8830142]\nPhone - [p:+33 1 99 00 12 34]\n\nLed 14 engineers at Brightwater Studio. Build 2023.11.2.",
    "Curriculum vitae of [n:Helga Brandt-Osterly]\nPersonalausweis [i:T22000129]\nTelefon: [p:030 23125 440]\n[s:Lindenstraße 14, 20095 Hamburg]\n\nResponsible for legacy Java services, version 12.4.9, on 30 node clusters.",
    "[n:Ivan Petrelov], ID: [i:4410 2093 7756], [p:+61491570110], [s:9 Quarry Road, 60211 Norvik], [e:ivan-petrelov AT post DOT example DOT org]\n\nTaught Scala to the mobile team once a month.",
    "[n:KARIN SOLBERG]\nEngineering Manager\n[e:karin@solberg.example]\n\nCertified in Terraform; studied theatre tuition for 9 months. Related: RFC 7231. Related: PO-2021-003344.",
    "[n:Jonas van der Meulen]\nData Analyst\ntel:[p:+31 20 555 0110]\n\nI was supervised by [n:Nora Lindqvist] from Copperfield Labs.\nEmergency contact: [n:Milo Hargrove], Seabright Group, [p:01632 960 771].",
    "Contract payments engineer\n\nReference: [n:Yorvil Manstrang], Oakline Partners ([e:yorvil@oakline.example]).\nWorked closely with [n:Paula Estevez] and the Harbor Point team.",
    "Staff QA Engineer\n\nReferee - [n:T. Vandersloot], Ironbark Logistics, [p:+1 312 555 0167].\nAlso ISBN 0-552-13311-8. Host 192.0.2.77.",
    "Reported to [n:Kestrel Odunmi] at Fernhill Software. Order 77120 331 90. Account 4402 1180 2291.",
    "Nombre: [n:Inés Caldera]\nTeléfono: [p:+34 910 555 123]\nDNI [i:40123456Q]\n[s:Calle del Olmo 12, 28004 Madrid]\n\nFormada en Kubernetes y Terraform. Trabajó en el proyecto Puerto Nuevo.",
    "Nom: [n:Mireille Fauconnet]\nTéléphone: [p:01.99.00.44.10]\n[s:12 bis rue des Lilas, 75011 Paris]\nCorreo: [e:mireille.fauconnet@boite.example]\n\nMaintenance du portail Grand Large chez Atelier Rivage.",
    "[n:Rahel Zimbrowski]\nnino: [i:QQ 12 34 56 C]\nmobile [p:07700 900 318]\n\nMaintained the upload client. Ref 22-118-04. Presented to 14 partners of Anchorbay Systems.",
    "Aadhaar [i:5512 8830 1147]. Reach me on [p:+91 98765 43210]. [s:44 Banyan Avenue, Flat 3B]\n\n[n:Goran Malhotresh] wrote the pragmatic handbook for lift charging.",
    "tax id [i:911 702 338]\n[e:w.tessler@mail.example] · [p:206-555-0133]\n\n[n:Willem Tessler] led the Cedar Grove project. Pull request 4471. Release 20240118.",
    "For checks: [i:944201773]. Write to [e:lena_marsh [at] inbox [dot] example].\n\nWide knowledge of Go and MySQL. Serial 8820-114-553. Page 120 of 400.",
    "[n:Vera Ombrecht]\nSecurity Engineer\nHandy: [p:0171 9988776]\n[s:Am Kirchplatz 3, Altmark]\n\nI am a careful person. Name a tool and I learn it. Batch 20231107 ran on 11 nodes.",
    "[n:É. Caradec]  [p:+33 199 00 77 12]\n\nPrototyped the crawler at Orchard Partners. Advanced Vue and NumPy. Version 17.10.21.",
    "Dr. [n:Xenia Abelard] managed the ranking group. Prof. [n:Lothar Wexstrand] taught me statistics. Dear reader, Machine Learning is my field.",
    "Mentored by [n:Aldous Prewitt] while at Granite Works. Working Kubernetes, Spark and Airflow. Daily SAML and Elixir.\nSigned, [n:Tessa Quindry]",
    "Regards,\n[n:Zara Oyelowe]\n\nSenior Platform Engineer. Basic Airflow and Ruby. Taught Kubernetes to the editorial team.",
    "[n:Ulla Sandgren]\nTechnical Writer\n\n[n:Ulla Sandgren] wrote the regional handbook. And then [n:Sandgren] moved to Blue Harbor Media.",
    "Sincerely,\n[n:Borlan Eskerud]\n\nFor two years [n:Borlan Eskerud] ran the support desk. Customers of Silver Lake Studio knew [n:Eskerud] well.",
    "[n:Tarek Nasrallian]\n[s:310 N. Harbor Blvd, Suite 12, Port Elling]\n[p:1-206-555-0170]\n\nSee the Harbor Terrace project. Worked on the 88 Park Avenue Capital account.",
    "Ring [p:(0161) 496 0321] or [p:+44 7700 900 555 ext. 12]. Fax [p:0161 4960322].\n\nInvoice 0161-4960-3 was closed. Sprint 20, section 12. 1546,38800 rows.",
    "identity card [i:AB123456]. national insurance number [i:QQ998877A]. social security [i:900-12-3456].\n\nSprint 912-44 closed 31 tickets. Commit ab12cd34.",
    "[e:first.last@sub.domain.example], [e:x_y@corp.example]\n\nFollow @data_daily on chat. Docs at https://wiki.example/page. Emails go through the mail relay. Postgres 15.2, Redis 7.0.12.",
    "[s:Via Garibaldi 21, Torino]\n[n:Chiarina Montalvo]\n\nProgetto Lago Azzurro presso Officina Nord. Certificata in Terraform.",
    "[s:156 Quarry Lane]; my inbox is [e:m-vela6@inbox.example].\n\n[n:Mirela Velanova], Scrum Coach. Reviewed the queue at Bramble Analytics. Looking for a careful localization engineer position.",
    "Also 48 rows of 2024.03.11, part 991-203-11, room 4021, port 8080, SKU 00912 33 18, case 12-90-441.\n\nHonest Machine Translation and Quality Assurance work at Lantern Collective.",
    "Account 020 7946 0018 3 was merged; project 212-555 was dropped; ticket 0151 2345678 stays open; order 312 555 0199.",
    "See invoice 030 23125 99 and build 900-11-2233. See the Rose Street portal and the 14 Elm Street Foods account. Contact: [i:988 12 7001].",
    "[n:Edwin Kjaerholt] (tel [p:+47 22 555 014]). [n:Farah Dilmaghani] (cell [p:312.555.0188]).\n\nProduct Manager at Meadow Software; Team Lead at Crownpoint Partners.",
    "Professional summary: Senior Data Engineer. Spring Boot, Google Cloud, Visual Studio and New Relic. English, German. San Porto, New Harbor.",
    "[n:Nora Ellingboe]\nReferences: [n:Kasper Dromgoole] of Tidewater Labs; [n:Olaf Brennick] of Moss Group.\n\nPresented the Bright Future program at Northern Lights Conference.",
    "recommended by [n:Sabelo Ntuliso], Emberline Systems. Kept the Blue Whale cluster alive. Summer Release shipped in Old Town.",
    "Hello from [n:yusuf demirkan].\ncontact: [e:yusuf@demirkan.example]\n\nautomated the intake of the Green Field account.",
    "[n:Paula-Marie O'Hanrahan]\nSupport Engineer\n[p:00 44 1632 960 229]\n\nWrote the Open Handbook. Deep Grafana and Parquet. Advanced Spark and Vue.",
    "[n:Lindstrom, Jonas]  [p:+46 8 555 01 23]\nBackend Developer\n\nBenchmarked the Night Owl service. Presented a Lightning Talk at Data Days.",
    "Candidate: [n:Ottoline Vass]\nApplicant number 20240017\n\n[n:Ottoline Vass] has led the Stone Bridge team. Contact via [e:ottoline.vass@jobs.example].",
    "cv of [n:Rasmus Tjelde]\nphone: [p:0555 014 2881]\nsin [i:046 454 286]\n\nQuiet Hours planner, Open Source work. Certified Scrum Master.",
    "[n:A. Pemberley]\nUX Researcher\nPhone number is [p:0044 1632 960733]\n\nAnna Street project and Kings Road team were mine. Class of 2012. Issue 914-22-10.",
    "[n:Fjodor Arinsk], [s:Ronda de Segovia 8], DNI: [i:X1234567L]\n\nHardened the Legacy Fraud layer at Saffron Studio.",
    "Email [e:karin.odell@team.example]; backup [e:k2@alt.example]. My number is [p:+1 (415) 555-0190].\n\n[n:Karin O'Dell] mentors Junior Developers. Version v4.8.50.",
    "[n:Radan Milosz]\nDeveloper Advocate\nAddress: [s:43 Old Mill Road] #16A, 30800 Port Harnfield\n\nShipped the index at Copperwave Cooperative, cutting its cost by 4 percent.",
    "[n:OLAF BRENNICK]\nDeveloper Advocate\n[s:203 Amber Street] #1B, Lake Norvale\n\nReferee - [n:Kasia Wendt], Timberway Cooperative - [e:kasia@timber.example]",
    "Reference: [n:Estrid Holm] of Orchardway Institute. Reported to [n:Jaro Pell] from Cobaltway Union. Presented the audit to 29 partners of Moorland Council.",
    "Site Reliability Engineer\n[s:130 avenue du Moulin] after six, or [s:4 impasse des Roses], please. I live at [s:55 rue Haute]\n\nBased in New Elyburg, near Upper Dunmoor.",
    "I live at [s:8 chemin de la Source] for now. Domicilio: [s:Paseo del Prado 8]; Anschrift: [s:Lindenweg 9].\nAlba went to Harnfield and Bruno was with us. Ask for Milo.",
    "Customer Success Manager\nSupport Lead\n\nWorked with [n:Ivan Grosk] in Port Anselm. Led by [n:Helga Morn] at Rosewood College; Head Architect, Quality Officer.",
    "[n:Lena Ashgrove]\nData Scientist\n[s:334 Old Mill Road] #20D, 56296 New Ostmoor\nor [s:31 Tanner Row] #2B, New Ibrask\nor [s:171 Elm Crescent] #10B, 55686 Lake Marbruck; \n\nHelped Junior Testers of Pebblefield Association grow.",
    "Tax ID: [i:00448120931]\n\nFor payroll: Aadhaar [i:078160044721] after six. National Insurance [i:QQ440973B] after six.\n[n:Dalia Hovik]",
    "Steuer-ID [i:00371100258]; Personal ID no. [i:00662019041]) and Tax ID [i:88120044193]. Fax: [p:0049 (0)30 23125 110]\ntel:[p:0044 1632 960 118]",
    "Contact: Tax ID: [i:00981103442]; also the Harbor Terrace project.\n(Tax ID: [i:00365503112]; certified in Go. Call [p:0033 1 99 00 31 22].",
    "For checks: National Insurance [i:QQ014411B] after six. nino [i:QQ 77 20 11 A], or ring [p:0161 496 0144].",
    "Reported to Dr. [n:Halver-Brand, Alba] from Fablegrid Group. Recommended by Ms. [n:Tarnow, Jonas] of Velvetbay Systems.\nReference: Prof. [n:Morow, Carla] of Maplehook Cooperative ([p:+1 312 555 0148]).",
    "I was supervised by Prof. [n:McVeris, Nora] of Willowgate Labs.\nEmergency contact: Dr. [n:Aldan, Ivan] of Emberforge Studio.\nWorked closely with Ms. [n:Gresis, Petra-Lena] from Timbernook Group.",
    "Emergency contact: [n:Maribel Nisk] from Cobaltbay Software ([p:+1 312 555 0121]).\nReference: [n:Nadia Obrum] from Hollowgate Labs, [p:(617) 555 0190].\nBuilt the board at Granitehook Cooperative, cutting its cost by 5 percent.",
    "Referee - [n:Leandro Kelg] from Driftgate Partners, [p:1-415-555-0133].\nWorked with Ms. [n:Greta Haldan-Rick] from Brambleforge Labs, [p:+49 30 23125 771].\nBuilt the index at Saffronhook Software, cutting its cost by 8 percent.",
    "Reported to [n:B. Sodwell] from Orchardforge Cooperative, [p:+1 415 555 0199].\nReferee - [n:Q. L. Ruth-Kelan] from Saffronbay Group ([p:+44 7700 900 118]). Presented to 4 partners of Velvetgrid Studio.",
    "Passport nr. [i:C01000447]. Passport number [i:L2104418]. id no. [i:990117305].\nVersion 990117305 was skipped. Ticket L2104418 too.",
)
